"""Package marker; see the modules."""
