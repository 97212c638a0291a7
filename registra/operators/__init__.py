"""Register reports, as DataFrame plans."""
