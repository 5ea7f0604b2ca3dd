"""Documents that arrive one after another."""
