"""What is decided before a plan is made, and what is measured while it runs."""
