"""functions of the game-tree engine."""
