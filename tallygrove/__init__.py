"""Analytics over repeated measures, as lazy DataFrame plans."""
