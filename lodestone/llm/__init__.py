"""Training-data operators: de-duplication, filtering, scoring, mixing and tokenising at corpus scale."""
