"""Readers. Every reader returns a DataFrame with a fixed schema; none infers one."""
