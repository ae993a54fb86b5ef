"""Value semantics and text functions as columns."""
