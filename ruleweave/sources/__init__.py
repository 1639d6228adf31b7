"""Where facts come from and go to."""
