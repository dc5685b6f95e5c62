"""Where the data come from: domain relations over the given tables, store catalogues, encrypted payloads."""
