"""The loan feature pack: six table summaries and the plan that joins them."""
