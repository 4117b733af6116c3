"""Where logs come from and reports go."""
