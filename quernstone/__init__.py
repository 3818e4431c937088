"""Quernstone: text-corpus and event-window analytics as composable PySpark DataFrame operators."""
