"""orderlens.sources"""
