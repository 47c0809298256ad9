"""Log replay and micro-batch capture as streams."""
