"""Keyed state over events: anchored rate windows and expiry, in batches and as streams."""
