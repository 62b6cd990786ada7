"""From constraint text to DataFrame plans."""
