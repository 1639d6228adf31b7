"""Rule conditions and queries as DataFrame plans."""
