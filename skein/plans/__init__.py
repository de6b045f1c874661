"""How jobs are laid out: staged tables, partition sizes."""
