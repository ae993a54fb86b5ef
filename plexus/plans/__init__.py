"""Query languages and their plans."""
