"""A PySpark-native engine for save-game style data: sources, decoders and domain-neutral DataFrame operators."""
