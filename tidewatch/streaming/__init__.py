"""The peak signal on arriving data."""
