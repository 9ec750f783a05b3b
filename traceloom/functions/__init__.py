"""Column functions of the business data: order numbers, dates, numbers, flags and keys."""
