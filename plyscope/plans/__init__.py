"""plans of the game-tree engine."""
