"""orderlens.streaming"""
