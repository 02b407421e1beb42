"""Bindings of the driver tables to the data model, and the registered queries."""
