"""Physical tables: readers, writers and manifests."""
