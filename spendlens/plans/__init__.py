"""The registered finance queries; importing the modules registers them."""

from spendlens.registry import ORACLE, QUERIES

from . import changes, inputs, ledger, planning, shopping, texts

__all__ = ["ORACLE", "QUERIES", "changes", "inputs", "ledger", "planning", "shopping", "texts"]
