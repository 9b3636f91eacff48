"""formweave subpackage."""
