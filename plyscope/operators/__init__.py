"""operators of the game-tree engine."""
