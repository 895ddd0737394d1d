"""Delivery-event analytics as deterministic DataFrame operators."""
