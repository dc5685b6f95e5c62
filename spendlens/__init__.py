"""Personal-finance analytics as DataFrame plans over whole ledgers."""
