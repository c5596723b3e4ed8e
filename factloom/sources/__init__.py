"""Readers, contract checks, model-reply attachment and the report sink."""
