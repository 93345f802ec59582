"""geoloom sub-package."""
