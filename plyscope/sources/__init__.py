"""sources of the game-tree engine."""
