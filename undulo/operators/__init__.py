"""Building, decoding and splitting."""
