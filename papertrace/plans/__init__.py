"""End-to-end plans: grade, reconcile, cost."""
