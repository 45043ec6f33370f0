"""Operators for preparing training text at scale. Nothing else in quernlex imports this."""
