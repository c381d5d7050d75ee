"""Result formats."""
