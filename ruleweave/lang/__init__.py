"""The rule language: text to syntax trees."""
