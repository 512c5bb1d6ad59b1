"""Query definitions grouped by area (imported for their registrations)."""
