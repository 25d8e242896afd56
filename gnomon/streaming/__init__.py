"""Stateful operators over streams of reports, requests and runs."""
