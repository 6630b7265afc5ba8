"""Files: binary log formats, and versioned manifests."""
