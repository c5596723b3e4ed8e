"""Row-level expressions: every function takes and returns a Column."""
