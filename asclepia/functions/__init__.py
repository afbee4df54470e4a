"""Operators on values inside a row: Column to Column, all built from Catalyst expressions."""
