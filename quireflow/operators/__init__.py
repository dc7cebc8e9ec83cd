"""DataFrame operators of the structuring engine."""
