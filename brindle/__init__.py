"""Brindle: an analytics engine that folds stage plans into Spark logical plans."""
