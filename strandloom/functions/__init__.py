"""See the modules of this sub-package."""
