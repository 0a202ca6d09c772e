"""Tables that cut lineage, as the library has them."""

from sieveyard.sources.staging import drop, shared_dir, stage

__all__ = ["drop", "shared_dir", "stage"]
