"""Table access: scans, CRM extracts, inline parameter tables."""
