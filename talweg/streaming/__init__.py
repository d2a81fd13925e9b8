"""Nothing here: the engine's capabilities are all batch, and none is invented for streams."""
