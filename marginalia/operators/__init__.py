"""Search, links and project listings over a DataFrame of notes."""
