"""Plans of several operators: context packages and project dossiers."""
