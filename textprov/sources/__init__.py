"""Where texts and artifacts come from and go to."""
