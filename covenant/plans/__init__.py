"""Views over data and their refresh."""
