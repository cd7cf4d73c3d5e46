"""Training-data operators: ten DataFrame operators and the helpers they share."""
