"""Query plans: each operator applied to whole tables, beside SQL that gives the same rows."""
