"""The given test tables seen as game-market inputs, and the same mapping in SQL."""
