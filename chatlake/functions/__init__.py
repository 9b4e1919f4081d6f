"""Column-level helpers (JS string semantics, scalar functions)."""
