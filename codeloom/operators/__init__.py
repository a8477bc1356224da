"""Operators over generic columns."""
