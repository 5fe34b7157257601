"""Decision forests: split search, training, scoring."""
