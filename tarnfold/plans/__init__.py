"""Which coordinates are updated when: dispatch orders, block plans, costs, tuning."""
