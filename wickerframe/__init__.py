"""Count-window analytics on PySpark: positions, windows, panes, window functions, batch and streaming."""
