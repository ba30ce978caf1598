"""Column expressions in the contract's semantics."""
