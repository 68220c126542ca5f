"""Sequential state per key."""
