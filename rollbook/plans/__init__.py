"""Task datasets and scoring frames composed of the operators."""
