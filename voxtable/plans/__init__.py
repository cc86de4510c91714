"""Registered rules, experiment tables and audits built from the operators."""
