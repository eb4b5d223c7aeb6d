"""Intermediate tables, as the rest of the library writes them."""

from quotelens.store import materialize, release, shared_dir

__all__ = ["materialize", "release", "shared_dir"]
