"""Readers and writers of the binary log and run formats."""
