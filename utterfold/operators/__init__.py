"""DataFrame operators for labelled text."""
