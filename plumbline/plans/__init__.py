"""Plans that put operators together: configurations, training runs, model seams and the registered queries."""
