"""Part of slantree."""
