"""Where notes come from: tables shaped as notes, and directory trees."""
