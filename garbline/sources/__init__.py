"""Table loaders, the derivation of domain tables, and the event stream source."""
