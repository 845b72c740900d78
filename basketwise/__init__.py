"""Mining of what changes together, and checking of change sets for what is missing, as DataFrame jobs."""
