"""Operators that turn catalog candidates into training data; nothing else imports this package."""
