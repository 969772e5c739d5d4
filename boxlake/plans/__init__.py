"""Registered queries and the tables they are made from."""
