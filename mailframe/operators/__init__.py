"""Operators over tables of mails."""
