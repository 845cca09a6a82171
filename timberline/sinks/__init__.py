"""Where reports go."""
