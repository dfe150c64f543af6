"""Cutting lineage in storage that all executors share, so that the work survives the loss of any of them."""

from packloom.storage import cut, new_path, shared_dir, stored

__all__ = ["cut", "new_path", "shared_dir", "stored"]
