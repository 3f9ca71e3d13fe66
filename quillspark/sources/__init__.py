"""Sources: policy, cursors, request safety, readers and recorded answers."""
