"""streaming of the game-tree engine."""
