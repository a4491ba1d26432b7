"""The training job and the registered queries."""
